"""inkspan: text-tell analytics and corpus preparation as Spark DataFrame operators."""
