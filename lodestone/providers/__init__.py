"""Where scores come from. Operators never ask how a score was made."""
