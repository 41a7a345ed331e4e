"""sellerlens.functions"""
