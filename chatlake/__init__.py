"""chatlake: message search, activity and storage analytics as Spark jobs."""
