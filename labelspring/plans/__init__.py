"""Multi-step jobs: Naive Bayes, EM, likelihood, trials, corpus preparation."""
