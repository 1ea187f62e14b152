"""corpusweave.operators"""
