"""hindcast.streaming"""
