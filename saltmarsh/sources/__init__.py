"""saltmarsh.sources"""
