"""quiver: vector-style analytics expressed as Spark DataFrame and Column operators."""
