"""saltmarsh.plans"""
