"""Entity resolution and corpus analytics as Spark DataFrame plans."""
