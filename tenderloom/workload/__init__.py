"""Named queries over the given tables, each with its SQL counterpart where SQL can say it."""
