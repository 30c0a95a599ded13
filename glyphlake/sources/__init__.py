"""glyphlake.sources"""
