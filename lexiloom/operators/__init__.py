"""lexiloom.operators"""
