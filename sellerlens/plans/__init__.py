"""sellerlens.plans"""
