"""Column expressions: kinematics, bins, text formats."""
