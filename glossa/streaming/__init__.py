"""Streaming.

The reference has no stream processing (no sources, watermarks or late
data); its only "streams" are output file handles.  Nothing is built here
by design: every operator in this package is a batch DataFrame function,
and the per-message feature extractors in ``glossa.operators.feats`` are
stateless per row, so they can be applied unchanged to a
``readStream`` DataFrame by a caller who needs it.
"""
