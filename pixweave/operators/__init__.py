"""pixweave.operators"""
