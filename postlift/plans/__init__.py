"""postlift.plans"""
