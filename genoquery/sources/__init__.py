"""genoquery.sources"""
