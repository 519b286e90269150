"""Transit delay analytics and corpus preparation, written as Spark DataFrame programs."""
