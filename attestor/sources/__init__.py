"""attestor.sources"""
