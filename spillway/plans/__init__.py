"""Pipeline definitions: nodes, checks, lowering to DataFrames, plan documents and inspection."""
