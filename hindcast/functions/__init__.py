"""hindcast.functions"""
