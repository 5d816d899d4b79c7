"""postlift.operators"""
