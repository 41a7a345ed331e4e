"""sellerlens.sinks"""
