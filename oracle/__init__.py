"""The same questions in plain SQL, to check the Spark queries against."""
