"""Task, mailbox and training-text analytics as Spark DataFrame jobs."""
