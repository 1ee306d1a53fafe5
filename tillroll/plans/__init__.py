from tillroll.plans.ranking import row_number_by

__all__ = ["row_number_by"]
