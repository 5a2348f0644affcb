"""larkstead: household content and work-queue analytics as Spark DataFrame plans."""
