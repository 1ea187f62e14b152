"""corpusweave.plans"""
