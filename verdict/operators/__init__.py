"""DataFrame operators: envelopes, scoring, answer validation, evaluation."""
