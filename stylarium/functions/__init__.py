"""Column expressions over texts: cleaning, style, surface overlap, quantities, facts."""
