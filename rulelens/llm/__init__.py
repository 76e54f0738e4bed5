"""Training-data operators: filters, dedup, decontamination, scoring, formatting and tokens. Nothing else imports this."""
