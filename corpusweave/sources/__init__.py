"""corpusweave.sources"""
