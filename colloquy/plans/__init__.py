"""Plan shapes shared by the operators, and the composed jobs."""
