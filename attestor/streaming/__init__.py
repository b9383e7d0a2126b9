"""attestor.streaming"""
