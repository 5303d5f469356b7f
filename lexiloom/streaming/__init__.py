"""lexiloom.streaming"""
