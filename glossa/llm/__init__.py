"""Training-data pipeline operators.

Each module holds one operator with its own general interface; ``queries``
registers one thin query per operator.  Nothing outside this subpackage
imports it.
"""
