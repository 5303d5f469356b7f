"""lexiloom.functions"""
