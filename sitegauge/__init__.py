"""Site-readiness analytics and corpus preparation as Spark plans."""
