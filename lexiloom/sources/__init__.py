"""lexiloom.sources"""
