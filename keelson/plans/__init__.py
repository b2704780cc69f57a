"""Multi-stage plans: fused preprocessing fit, train and score workflows."""
