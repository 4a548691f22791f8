"""genoquery.plans"""
