"""corpusweave.streaming"""
