"""saltmarsh.functions"""
