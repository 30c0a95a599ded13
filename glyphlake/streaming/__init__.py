"""glyphlake.streaming"""
