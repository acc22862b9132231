"""The transformations: DataFrame in, DataFrame out."""
