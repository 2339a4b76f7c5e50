"""Where entries come from: JSON values, the operation log, stored versions."""
