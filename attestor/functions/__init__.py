"""attestor.functions"""
