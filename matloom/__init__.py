"""matloom: matrix statistics and linear algebra as Spark DataFrame plans."""
