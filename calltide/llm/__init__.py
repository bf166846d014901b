"""Training-data operators over ``documents``, ``benchmark``, ``labels`` and ``conversations``.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
