"""genoquery.functions"""
