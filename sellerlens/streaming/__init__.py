"""sellerlens.streaming"""
