"""Training-data operators: one module per operator, ``queries`` registers them.

Nothing outside this folder imports it; general helpers of the library
(session, checkpoint folder) are used from here.
"""
