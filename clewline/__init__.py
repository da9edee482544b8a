"""clewline: URL-evidence analytics as Spark DataFrame operators."""
