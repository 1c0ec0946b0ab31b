"""What is settled on the driver before a query runs: schemas, prompts, dispatch."""
