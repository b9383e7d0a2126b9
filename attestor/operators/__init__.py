"""attestor.operators"""
