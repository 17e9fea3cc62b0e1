"""pixweave.sources"""
