"""sellerlens.sources"""
