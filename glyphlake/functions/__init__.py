"""glyphlake.functions"""
