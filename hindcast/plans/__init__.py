"""hindcast.plans"""
