"""sellerlens.operators"""
