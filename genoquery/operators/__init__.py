"""genoquery.operators"""
