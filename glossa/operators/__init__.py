"""Operators: plain functions ``DataFrame -> DataFrame``.

The canonical interchange type is the long feature table
``(group_id, feat string, value double, group_norm double)``; a feature
that is absent for a group is 0.
"""
