"""hindcast.operators"""
