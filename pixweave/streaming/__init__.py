"""pixweave.streaming"""
