"""glyphlake.operators"""
