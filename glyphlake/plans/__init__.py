"""glyphlake.plans"""
