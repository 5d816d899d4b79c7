"""postlift.functions"""
