"""The parameterised questions (lenses) as typed DataFrames, and their text renderings."""
