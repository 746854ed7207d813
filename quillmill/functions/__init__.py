"""Column functions, and the few Python functions that SQL cannot express."""
