"""saltmarsh.streaming"""
