"""The row-local operators on streams.

No operator here keeps streaming state: a score, a rule, a request or a parsed
reply depends on its own row only, so the batch functions run unchanged.
"""
