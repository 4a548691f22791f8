"""genoquery.streaming"""
