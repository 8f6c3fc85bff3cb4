"""saltmarsh.operators"""
