"""Training-data operators: each module holds one operator, its query and, where SQL can express it, its SQL.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
