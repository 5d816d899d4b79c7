"""postlift.streaming"""
