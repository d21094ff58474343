"""Column-level functions: identities, text rules, token counts, vector arithmetic."""
