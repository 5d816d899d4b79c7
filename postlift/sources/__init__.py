"""postlift.sources"""
