"""Readers and writers: bag-of-words files, text folders, set tables, truth, results."""
