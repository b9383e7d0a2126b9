"""attestor.plans"""
