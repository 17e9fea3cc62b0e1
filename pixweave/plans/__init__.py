"""pixweave.plans"""
