"""The log of served queries as a stream; beyond what the batch operators need."""
